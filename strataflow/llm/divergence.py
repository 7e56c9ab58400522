"""Source divergence audit: how far the sources of a language differ in their words, exactly.

Words are found by a byte-level tokenizer: a lookup table over the concatenated UTF-8 texts of a batch says which bytes
belong to words and lower-cases A-Z, and the places where that changes are the words' bounds. Words are grouped by xxHash,
each word compared byte by byte with the first of its group, so that a collision parts them. Counts go from there to Spark
as rows of (language, source, word), combined in each task and again by the shuffle.

Divergences are sums over all kept words of a language. A word that neither source has gives the same term whatever the
word, one that a single source has depends on that source's count alone; so only the counts above zero are held (as CSR
matrices: by source for the sums over its own words, by word for the words two sources share), and the rest is a product.
A task takes one bucket of a language's words and one pair of tiles of its sources; sums of buckets are added by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataflow.llm.common import materialize

#: A word must be in so many documents of its language; as many words of a source are told.
LEAST, TOLD = 10, 10
#: Counts above zero in a bucket of words, sources in a tile, bytes of text looked at together, rows of counts that a task combines before it sends them.
BUCKET, TILE, BYTES, ROWS = 1 << 18, 512, 1 << 20, 1 << 17
SCALE = 1_000_000_000

_CODES = np.arange(256)
_IN_WORD = (_CODES >= 0x80) | ((_CODES >= 0x41) & (_CODES <= 0x5A)) | ((_CODES >= 0x61) & (_CODES <= 0x7A))
_LOWER = np.where((_CODES >= 0x41) & (_CODES <= 0x5A), _CODES + 32, _CODES).astype(np.uint8)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each word in data, the bytes of documents that begin at offsets[:-1]; none runs over a document's end."""
    inside = _IN_WORD[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges], after[edges - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def group_words(text: bytes, starts: np.ndarray, ends: np.ndarray, digest: Callable[[bytes], int] = xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """A number for each slice, equal for equal bytes, and the place (among the slices) of the first slice of each number."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = np.fromiter((digest(text[a:b]) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, n)
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    model, lengths = first[number], ends - starts
    unlike = lengths != lengths[model]
    same = np.flatnonzero(~unlike)
    data, sizes = np.frombuffer(text, np.uint8), lengths[same]
    begin = np.cumsum(sizes) - sizes
    inner = np.arange(int(sizes.sum())) - np.repeat(begin, sizes)
    differs = data[np.repeat(starts[same], sizes) + inner] != data[np.repeat(starts[model[same]], sizes) + inner]
    unlike[same] = np.add.reduceat(differs, begin, dtype=np.int64) > 0
    extra, firsts = {}, first.tolist()
    for i in np.flatnonzero(unlike).tolist():  # collisions: another word of the same hash
        word = text[starts[i] : ends[i]]
        if word not in extra:
            extra[word] = len(firsts)
            firsts.append(i)
        number[i] = extra[word]
    return number.astype(np.int64), np.array(firsts, np.int64)


_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _count_some(texts: pa.Array, lang: pa.Array, source: pa.Array) -> pa.Table:
    """_COUNTS of a few documents, and a row without a term for each of their groups."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    groups = pa.table({"lang": lang, "source": source}).group_by(["lang", "source"], use_threads=False).aggregate([])
    known = {pair: i for i, pair in enumerate(zip(groups["lang"].to_pylist(), groups["source"].to_pylist()))}
    of_doc = np.array([known[pair] for pair in zip(lang.to_pylist(), source.to_pylist())], np.int64)
    starts, ends, doc = word_bounds(data, offsets - offsets[0])
    text = _LOWER[data].tobytes()
    number, first = group_words(text, starts, ends)
    bare = groups.append_column("term", pa.nulls(len(groups), pa.string())).append_column("n", pa.array([0] * len(groups), pa.int64()))
    bare = bare.append_column("docs", pa.array([0] * len(groups), pa.int64())).cast(_COUNTS)
    if not len(number):
        return bare
    in_doc, n = np.unique(doc * len(first) + number, return_counts=True)
    in_group = of_doc[in_doc // len(first)] * len(first) + in_doc % len(first)
    order = np.argsort(in_group, kind="stable")
    codes, at = np.unique(in_group[order], return_index=True)
    words = pa.array([text[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())], pa.binary()).cast(pa.string())
    which = groups.take(pa.array(codes // len(first)))
    found = pa.table({
        "lang": which["lang"], "source": which["source"], "term": words.take(pa.array(codes % len(first))),
        "n": np.add.reduceat(n[order], at), "docs": np.diff(np.append(at, len(order))),
    }, _COUNTS)
    return pa.concat_tables([bare, found])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []

    def combined() -> pa.Table:
        sums = pa.concat_tables(held).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
        return sums.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(_COUNTS.names).cast(_COUNTS)

    for batch in batches:
        text = batch.column("text").cast(pa.string())
        sizes = np.diff(np.frombuffer(text.buffers()[1], np.int32, len(text) + 1, text.offset * 4)) if len(text) else np.zeros(0, np.int64)
        ends = np.cumsum(sizes, dtype=np.int64) // BYTES
        for piece in np.split(np.arange(len(text)), np.flatnonzero(np.diff(ends)) + 1):
            if len(piece):
                at, many = int(piece[0]), len(piece)
                held.append(_count_some(text.slice(at, many), batch.column("lang").slice(at, many), batch.column("source").slice(at, many)))
        if sum(map(len, held)) > ROWS:
            held = [combined()]
            if len(held[0]) > ROWS // 2:
                yield from held[0].to_batches()
                held = []
    if held:
        yield from combined().to_batches()


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs of docs(text, lang, source): occurrences of each word and documents that have it.

    Null text, lang and source are ''. Each group has a row with a null term besides, so one without any words is told too.
    """
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counted = plain.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    # Dealt by word, so that what looks at all sources of a word needs no further shuffle.
    return counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# -- divergences of one bucket of words


def shares(count: np.ndarray, total: np.ndarray, kinds: int) -> np.ndarray:
    """1 + floor(SCALE (count + 2) / (total + 2 kinds)), exact."""
    count, total = np.asarray(count), np.asarray(total)
    if len(count) and int(count.max()) + 2 > (1 << 62) // SCALE:
        count, total = count.astype(object), total.astype(object)
    return (1 + SCALE * (count + 2) // (total + 2 * kinds)).astype(np.int64)


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def pair_sums(source: np.ndarray, term: np.ndarray, p: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """The sum of gap() over the words for each pair of sources, less gap() of their shares of a word they lack for each word.

    source, term, p are the entries of a matrix of counts above zero; zero is each source's share of a word it lacks.
    """
    many = len(zero)
    alone = np.zeros((many, many), np.int64)
    by_source = np.argsort(source, kind="stable")
    step = max(1, (1 << 20) // max(many, 1))
    for at in range(0, len(source), step):
        rows = by_source[at : at + step]
        have, first = np.unique(source[rows], return_index=True)
        alone[have] += np.add.reduceat(gap(p[rows][:, None], zero[None, :]) - gap(zero[source[rows]][:, None], zero[None, :]), first, axis=0)
    both = np.zeros((many, many), np.int64)
    by_term = np.lexsort((source, term))
    s, t, v = source[by_term], term[by_term], p[by_term]
    for apart in range(1, many):  # the words that two sources share, each pair of entries of a word once
        i = np.flatnonzero(t[apart:] == t[:-apart])
        if not len(i):
            break
        j = i + apart
        more = gap(v[i], v[j]) - gap(v[i], zero[s[j]]) - gap(zero[s[i]], v[j]) + gap(zero[s[i]], zero[s[j]])
        code = s[i] * many + s[j]
        order = np.argsort(code, kind="stable")
        found, first = np.unique(code[order], return_index=True)
        both.reshape(-1)[found] += np.add.reduceat(more[order], first)
    return alone + alone.T + both + both.T


_RESULT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _diverge(key: tuple[pa.Scalar, ...], counts: pa.Table, sources: pa.Table) -> pa.Table:
    """Partial sums of pairs, and the first words of each source, for one bucket of words and one pair of tiles of sources."""
    lang, bucket, one, other = (k.as_py() for k in key)
    if not len(sources):
        return _RESULT.empty_table()
    names = sources["source"].to_pylist()
    tile, total, kinds = sources["tile"].to_numpy(), sources["total"].to_numpy(), sources["kinds"][0].as_py()
    out = []

    def rows(source: np.ndarray, part: str, item: pa.Array, value: np.ndarray) -> None:
        out.append(pa.table({
            "lang": pa.repeat(pa.scalar(lang, pa.string()), len(value)), "source": pa.array(names, pa.string()).take(pa.array(source)),
            "part": pa.repeat(pa.scalar(part), len(value)), "item": item, "value": value,
        }, _RESULT))

    sums = np.zeros((len(names), len(names)), np.int64)
    if kinds:
        zero = shares(np.zeros(len(names), np.int64), total, kinds)
        place = {name: i for i, name in enumerate(names)}
        source = np.array([place[x] for x in counts["source"].to_pylist()], np.int64)
        words = counts["term"].combine_chunks().dictionary_encode() if len(counts) else None
        if words is not None:
            term = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            p = shares(counts["n"].to_numpy(), total[source], kinds)
            sums += pair_sums(source, term, p, zero)
            if one == other:
                q = shares(counts["in_lang"].to_numpy(), np.full(len(p), sources["in_lang"][0].as_py()), kinds)
                over = np.flatnonzero(p > q)
                alphabet = np.argsort(np.argsort(np.array(words.dictionary.cast(pa.binary()).to_pylist(), object), kind="stable"))
                value = gap(p[over], q[over])
                order = over[np.lexsort((alphabet[term[over]], -value, source[over]))]
                value = gap(p[order], q[order])
                have, first = np.unique(source[order], return_index=True)
                rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
                top = rank < TOLD
                rows(source[order][top], "term", words.dictionary.take(pa.array(term[order][top])), value[top])
        if bucket == 0:
            sums += kinds * gap(zero[:, None], zero[None, :])
    # Pairs of one tile with the other, both ways.
    a, b = np.nonzero(((tile[:, None] == one) & (tile[None, :] == other)) | ((tile[:, None] == other) & (tile[None, :] == one)))
    a, b = a[a != b], b[a != b]
    rows(a, "pair", pa.array(names, pa.string()).take(pa.array(b)), sums[a, b])
    return pa.concat_tables(out)


def divergence(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from its others, and by which words from the whole.

    docs has text, lang, source; other columns do not matter. Nulls are '', a repeated row is a document of its own. A
    language keeps the words that at least `least` of its documents have. Part 'pair' has each other source of the language
    (value 0 where it keeps no words), part 'term' the TOLD words a source has most above its language. Ranks go by value,
    the highest first, then by item. An empty table gives no rows.
    """
    by_word = Window.partitionBy("lang", "term")
    counts = word_counts(docs).select(
        "lang", "source", "term", "n", F.sum("docs").over(by_word).alias("_docs"), F.sum("n").over(by_word).alias("in_lang"),
        (F.row_number().over(by_word.orderBy("source")) == 1).cast("long").alias("_one"),
    )
    counts = materialize(counts.filter(F.col("term").isNull() | (F.col("_docs") >= least)).drop("_docs"), "divergence-counts")
    kept = counts.filter(F.col("term").isNotNull())
    langs = kept.groupBy("lang").agg(F.sum("_one").alias("kinds"), F.sum("n").alias("in_lang"), F.ceil(F.count("*") / BUCKET).alias("_buckets"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    sources = (
        counts.filter(F.col("term").isNull()).select("lang", "source").join(own, ["lang", "source"], "left").join(langs, "lang", "left")
        .select("lang", "source", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("total", "kinds", "in_lang")],
                F.greatest(F.coalesce("_buckets", F.lit(1)), F.lit(1)).cast("int").alias("_buckets"), F.floor(place / TILE).cast("int").alias("tile"))
        .withColumn("_tiles", F.max("tile").over(Window.partitionBy("lang")) + 1)
    )
    sources = materialize(sources, "divergence-sources")
    # A source's rows go to every pair of tiles that has its own.
    pairs = F.transform(F.sequence(F.lit(0), F.col("_tiles") - 1), lambda k: F.struct(F.least(k, F.col("tile")).alias("one"), F.greatest(k, F.col("tile")).alias("other")))
    about = sources.select("*", F.explode(pairs).alias("_pair")).select("*", F.explode(F.sequence(F.lit(0), F.col("_buckets") - 1)).alias("bucket"))
    about = about.select("lang", "bucket", "_pair.one", "_pair.other", "source", "tile", "total", "kinds", "in_lang")
    dealt = kept.join(sources.select("lang", "source", "tile", "_tiles", "_buckets"), ["lang", "source"])
    dealt = dealt.select("lang", F.pmod(F.xxhash64("term"), F.col("_buckets")).cast("int").alias("bucket"), "source", "term", "n", "in_lang", F.explode(pairs).alias("_pair"))
    dealt = dealt.select("lang", "bucket", "_pair.one", "_pair.other", "source", "term", "n", "in_lang")
    key = ["lang", "bucket", "one", "other"]
    found = dealt.groupBy(*key).cogroup(about.groupBy(*key)).applyInArrow(_diverge, "lang string, source string, part string, item string, value long")
    found = materialize(found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")), "divergence-sums")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return found.withColumn("rank", rank.cast("int")).filter((F.col("part") == "pair") | (F.col("rank") <= TOLD))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
tok AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM d),
low AS (SELECT r, lang, source, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM tok),
kept AS (SELECT lang, term, count(*) AS tn FROM low GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
voc AS (SELECT lang, count(*) AS kinds, CAST(sum(tn) AS BIGINT) AS nl FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM low JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
ns AS (SELECT g.lang, g.source, CAST(coalesce(sum(c.n), 0) AS BIGINT) AS total FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
p AS (
  SELECT ns.lang, ns.source, kept.term, coalesce(c.n, 0) AS n,
         1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (ns.total + 2 * voc.kinds) AS p,
         1 + (1000000000 * (kept.tn + 2)) // (voc.nl + 2 * voc.kinds) AS q
  FROM ns JOIN voc ON voc.lang = ns.lang JOIN kept ON kept.lang = ns.lang
  LEFT JOIN c ON c.lang = ns.lang AND c.source = ns.source AND c.term = kept.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS BIGINT) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sums.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
