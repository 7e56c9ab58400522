"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A document is a bag of terms (its words) with their counts as weights. For sample k and a term of weight w, with r and c
of Gamma(2, 1) and b uniform, all drawn from the term and k alone:

    t = floor(ln w / r + b),   a = c exp(-r (t - b + 1))

and the sample is the term of smallest a with its t. Two documents agree in a sample with a probability of their
generalised Jaccard similarity, sum of min(weights) over sum of max(weights). A sample is kept as 16 bits of its (term, t),
so different ones agree by chance once in 65,536.

With f the fraction of ln w / r + b, a is (c / w) exp(-r (1 - f)), which needs no logarithm of c. A Gamma(2, 1) value is
-ln(u v) of two uniforms. A uniform is made as f / 2^e, with f evenly in [1, 2) and e geometric (from the trailing zeros of
13 bits), so its logarithm is e ln 2 less a short series in f; the exponential is a power of two and a short series. Both
are right to 3e-6, finer than the steps of the uniforms, and several times as fast as the library's functions.

Every sample is one minimum of a long: a in the upper bits, the 16 bits below. So a document's fingerprint is an
aggregation over its terms, WIDTH samples to a row. Texts that belong to one row (a text and its edited one) share the
draws of their terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Samples in a fingerprint, rows that a bucket of neighbouring ids has on average, and the most buckets.
SAMPLES, BUCKET, BUCKETS = 64, 512, 1 << 16
#: Samples that one row of a term yields at once.
WIDTH = 2
_LN2 = 0.6931471805599453
#: a is under 32; scaled and with 16 bits below it fits 62 bits.
_SCALE = float(1 << 41)
#: The key of a term that the text does not hold.
_NONE = (1 << 63) - 1
#: Of a hash: the two fields of bits whose trailing zeros count, the guards above them, and a one in each.
_FIELDS, _GUARDS, _ONES = 8191 | 8191 << 27, 1 << 13 | 1 << 40, 1 | 1 << 27


def _horner(x: str, coefficients: list[float]) -> str:
    """The polynomial with these coefficients, the lowest power first."""
    text = f"{coefficients[-1]!r}D"
    for c in reversed(coefficients[:-1]):
        text = f"({c!r}D + {x} * {text})"
    return text


def _keys(terms: DataFrame, keep: list[str], bodies: int, width: int) -> DataFrame:
    """terms(keep..., _term, _group, _n0 ... (weights), _l0 ... (their logarithms), _i0 ... (_SCALE over them)) with _k0_0 ...: for each body the keys of the group's samples, smallest first.

    The steps are projections of their own, so each value is computed once and the generated methods stay small.
    """
    each = range(width)
    pairs = [(i, j) for i in range(bodies) for j in each]
    names = [f"{v}{j}" for v in "xy" for j in each]
    base = ["_term", "_group", *keep, *[f"_{v}{i}" for v in "nli" for i in range(bodies)]]

    def then(step: DataFrame, kept: list[str], *made: str) -> DataFrame:
        return step.selectExpr(*base, *kept, *made)

    def mantissa(h: str, shift: int) -> str:
        return f"((shiftrightunsigned({h}, {shift}) & 16383L) + 16384.5D)"

    # Divisions and logarithms may be null to the planner; coalesced they are not, which keeps the code short.
    step = terms.selectExpr(*base, "xxhash64(_term, _group) as _u").selectExpr(
        *base, *[f"xxhash64(_u, {2 * j}) as _x{j}" for j in each], *[f"xxhash64(_u, {2 * j + 1}) as _y{j}" for j in each]
    )
    step = then(
        step,
        [],
        *[f"(_{h} & {_FIELDS}L) | {_GUARDS}L as _v{h}" for h in names],
        *[f"{mantissa(f'_{h}', 13)} * {mantissa(f'_{h}', 40)} as _g{h}" for h in names],
        *[f"((shiftleft(shiftrightunsigned(_x{j}, 54), 10) | shiftrightunsigned(_y{j}, 54)) + 0.5D) * {2.0**-20!r}D as _b{j}" for j in each],
    )
    b, c, r = ([f"_{v}{j}" for j in each] for v in "bcr")
    two = f"{2.0**29!r}D"
    step = then(step, b, *[f"bit_count(~_v{h} & (_v{h} - {_ONES}L)) as _e{h}" for h in names], *[f"coalesce((_g{h} - {two}) / (_g{h} + {two}), 0D) as _z{h}" for h in names])
    step = then(step, b, *[f"_{v}{h}" for v in "ez" for h in names], *[f"_z{h} * _z{h} as _s{h}" for h in names])
    series = [2 / (2 * k + 1) for k in range(5)]  # of ln((1 + z) / (1 - z)) / z
    step = then(step, b, *[f"_e{h} * {_LN2!r}D + ({_LN2!r}D - _z{h} * {_horner(f'_s{h}', series)}) as _{'r' if h[0] == 'x' else 'c'}{h[1:]}" for h in names])
    step = then(step, [*b, *c, *r], *[f"coalesce(1D / _r{j}, 0D) as _o{j}" for j in each])
    step = then(step, [*c, *r], *[f"_l{i} * _o{j} + _b{j} as _q{i}_{j}" for i, j in pairs])
    q, t, h, p = ([f"_{v}{i}_{j}" for i, j in pairs] for v in "qthp")
    step = then(step, [*c, *r, *q], *[f"floor(_q{i}_{j}) as _t{i}_{j}" for i, j in pairs])
    step = then(step, [*c, *t], *[f"_r{j} * (1D - (_q{i}_{j} - _t{i}_{j})) as _h{i}_{j}" for i, j in pairs])
    step = then(step, [*c, *t, *h], *[f"cast(_h{i}_{j} * {1 / _LN2!r}D + 0.5D as int) as _p{i}_{j}" for i, j in pairs])
    step = then(step, [*c, *t, *p], *[f"_h{i}_{j} - _p{i}_{j} * {_LN2!r}D as _d{i}_{j}" for i, j in pairs])
    power = [1.0, -1.0, 1 / 2, -1 / 6, 1 / 24, -1 / 120]  # of exp(-d)
    return step.selectExpr(
        *keep,
        "_group",
        *[
            f"if(_n{i} > 0L, shiftleft(shiftright(cast(_c{j} * _i{i} * {_horner(f'_d{i}_{j}', power)} as bigint), _p{i}_{j}), 16)"
            f" | shiftrightunsigned(xxhash64(_term, _t{i}_{j}), 48), {_NONE}L) as _k{i}_{j}"
            for i, j in pairs
        ],
    )


def ordered_neighbours(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """bucket, place, ghost, doc_id, text, next_text of every row; next by ascending id (null first, equal ids by text), then the first.

    Ids are dealt into buckets of ranges, whose bounds are quantiles; the rows of a bound also go to the bucket before, as
    ghosts that follow its last row, and those of the first id to the last bucket. So texts are shuffled once and no task
    sees more than a few buckets.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    ids = rows.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"))
    n = ids.count()
    if not n:
        return rows.select(F.lit(0).alias("bucket"), F.lit(0).alias("place"), F.lit(0).alias("ghost"), "doc_id", "text", F.col("text").alias("next_text"))
    n_buckets = max(1, min(BUCKETS, n // BUCKET))
    steps = [k / n_buckets for k in range(1, n_buckets)]
    first, bounds = ids.agg(
        F.min("id"), F.percentile_approx("id", F.array(*[F.lit(x) for x in steps]) if steps else F.array(F.lit(0.5)), 10 * max(4096, n_buckets))
    ).first()
    bounds = sorted({x for x in bounds if x > first}) if steps else []
    # bounds[k] begins bucket k + 1; looked up in two steps
    wide = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[k : k + wide] for k in range(0, len(bounds), wide)]
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    if groups:
        heads = F.array(*[F.lit(g[0]) for g in groups])
        group = F.size(F.filter(heads, lambda x: x <= F.col("_key")))
        nested = F.array(*[F.array(*[F.lit(x) for x in g]) for g in groups])
        inside = F.size(F.filter(F.element_at(nested, F.col("_group")), lambda x: x <= F.col("_key")))
        bucket = F.when(F.col("_group") > 0, (F.col("_group") - 1) * wide + inside).otherwise(F.lit(0))
        begins = F.array_contains(F.element_at(nested, F.greatest(F.lit(1), F.col("_group"))), F.col("_key"))
    else:
        group, bucket, begins = F.lit(0), F.lit(0), F.lit(False)
    last = len(bounds)
    dealt = (
        rows.withColumn("_key", key)
        .withColumn("_group", group)
        .withColumn("_bucket", bucket.cast("int"))
        .withColumn("_ghost", F.when(F.col("_key") == first, F.lit(last)).when(begins, F.col("_bucket") - 1))
        .withColumn("_at", F.explode(F.array_compact(F.array(F.struct(F.col("_bucket").alias("bucket"), F.lit(0).alias("ghost")), F.when(F.col("_ghost").isNotNull(), F.struct(F.col("_ghost").cast("int").alias("bucket"), F.lit(1).alias("ghost")))))))
        .select("_at.bucket", "_at.ghost", "doc_id", "text")
    )
    order = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").asc_nulls_first(), "text")
    return dealt.select(
        "bucket", F.row_number().over(order).alias("place"), "ghost", "doc_id", "text", F.lead("text").over(order).alias("next_text")
    )


def edited_text(text: Column, following: Column) -> Column:
    """text, its last floor(n / 2) characters replaced by the first as many (or all) of the following."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def sampled(texts: DataFrame, keys: list[str], bodies: list[str], samples: int = SAMPLES) -> DataFrame:
    """keys and, for each column of bodies, an array of 16-bit numbers (-1 where there are no words).

    keys are unique, and the first body is never null. If texts is partitioned by some of the keys, nothing is shuffled:
    terms are counted and sampled where the text lies.
    """
    # One white-space character: a split by a single character needs no regular expression.
    plain = [F.translate(F.concat(F.lit(" "), F.col(c)), "\t\n\x0b\x0c\r", "     ") for c in bodies]
    each = texts.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("which"), c.alias("body")) for i, c in enumerate(plain)])).alias("x"))
    words = each.select(*keys, F.col("x.which").alias("_which"), F.explode(F.split("x.body", " ")).alias("_word"))
    # The empty words, the one before the first among them, stand for the text itself: one without words has a row too.
    own = F.col("_word") == ""
    words = words.select(*keys, "_which", F.when(~own, F.xxhash64("_word")).alias("_term"))
    # A hash of NULL is a number, so it is the weight that keeps the row of the text itself from being a term.
    weights = [F.count(F.when(F.col("_which") == i, F.col("_term"))).alias(f"_n{i}") for i in range(len(bodies))]
    terms = words.groupBy(*keys, "_term").agg(*weights)
    width = min(samples, WIDTH)
    if samples % width:
        raise ValueError(f"samples must be a multiple of {width}")
    heaviest = [F.greatest(F.lit(1), F.col(f"_n{i}")).cast("double") for i in range(len(bodies))]
    terms = terms.select(
        "*",
        *[F.coalesce(F.ln(w), F.lit(0.0)).alias(f"_l{i}") for i, w in enumerate(heaviest)],
        *[F.coalesce(F.lit(_SCALE) / w, F.lit(0.0)).alias(f"_i{i}") for i, w in enumerate(heaviest)],
    )
    groups = terms.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(samples // width - 1))))
    columns = [[f"_k{i}_{j}" for j in range(width)] for i in range(len(bodies))]
    found = _keys(groups, keys, len(bodies), width).groupBy(*keys, "_group").agg(*[F.min(c).alias(c) for row in columns for c in row])
    parts = [F.array(*[F.when(F.col(c) == _NONE, F.lit(-1)).otherwise(F.col(c).bitwiseAND(F.lit(65535))).cast("int") for c in row]) for row in columns]
    whole = [
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_group", part.alias("part")))), lambda x: x["part"])).alias(c)
        for c, part in zip(bodies, parts)
    ]
    return found.groupBy(*keys).agg(*whole)


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda z: z)) / F.size(a)


def as_string(samples: Column) -> Column:
    """Four lowercase hexadecimal digits for each sample; 'none' of the text without words is 'ffff'."""
    return F.lower(F.array_join(F.transform(samples, lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit(65535))), 4, "0")), ""))


def fingerprint_report(docs: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    A null text counts as empty; texts without words have one fingerprint, and likeness 1 to each other. Repeated rows
    follow each other in the order of ids and give repeated rows. A single row is its own next. An empty table gives none.
    """
    near = ordered_neighbours(docs, id_col, text_col).withColumn("edited", F.when(F.col("ghost") == 0, edited_text(F.col("text"), F.col("next_text"))))
    found = sampled(near, ["bucket", "place"], ["text", "edited"], samples)
    following = F.lead("text").over(Window.partitionBy("bucket").orderBy("place"))
    found = found.select("bucket", "place", "text", "edited", following.alias("following")).select(
        "bucket",
        "place",
        as_string(F.col("text")).alias("fingerprint"),
        as_string(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("text"), F.col("edited")).alias("near_edited"),
        likeness(F.col("text"), F.col("following")).alias("near_next"),
    )
    own = near.filter("ghost = 0").select(
        "bucket", "place", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256")
    )
    # Both sides have a row a document, so they are shuffled at every size.
    return own.join(found.hint("shuffle_hash"), ["bucket", "place"]).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )
